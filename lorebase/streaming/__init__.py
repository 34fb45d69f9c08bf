"""streaming of the evidence-history engine."""
