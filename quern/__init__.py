"""File recompression analytics on Spark: inventories of files as tables, codecs as functions over their bytes."""
