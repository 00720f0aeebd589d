"""pagelib: DataFrame operators for a library of web pages seen through time."""
