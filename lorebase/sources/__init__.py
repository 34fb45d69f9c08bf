"""sources of the evidence-history engine."""
