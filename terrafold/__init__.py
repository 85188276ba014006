"""Records, polygon features, mapping layers and edit streams as Spark DataFrames."""
