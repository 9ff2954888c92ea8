"""civicloom: DataFrame operators for public-record corpora on Apache Spark."""
