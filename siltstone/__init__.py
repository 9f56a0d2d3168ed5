"""siltstone: commercial data-quality and analytics jobs expressed as Spark plans."""
