"""Evidence-ledger analytics expressed as Spark DataFrame operators."""
