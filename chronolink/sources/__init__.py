"""Loading series, views over tables, and writing results."""
