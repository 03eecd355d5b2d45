"""Document-analytics engine on PySpark: scans, cleaning, layout, chunking, model map/reduce, rendering, state."""
