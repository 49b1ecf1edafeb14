"""folio: a Spark-native engine for collections of structured documents."""
