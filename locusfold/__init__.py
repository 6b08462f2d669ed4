"""locusfold: Spark-native analytics of tandem-repeat loci and the sequence around them."""
