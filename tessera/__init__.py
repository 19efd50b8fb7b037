"""Analytics over collections of source files and documents, as DataFrame functions on Spark."""
