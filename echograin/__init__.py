"""Full-waveform LiDAR analytics on Spark DataFrames."""
