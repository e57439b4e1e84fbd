"""wavespan: segmentation and measurement of long time series on PySpark."""
