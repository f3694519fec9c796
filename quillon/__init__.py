"""quillon: item, event and call-graph analytics expressed as Spark DataFrame plans."""
