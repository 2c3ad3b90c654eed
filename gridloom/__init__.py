"""gridloom: Spark-native multiresolution analytics for dense numeric grids."""
