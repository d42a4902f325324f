"""DataFrame operators over bars, trades, journals and documents."""
