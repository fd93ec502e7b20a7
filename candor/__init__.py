"""Analytics over evaluation records, as DataFrame operators."""
