"""Analytics over collections of contracts and similar documents, as DataFrame operators."""
