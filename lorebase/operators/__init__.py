"""operators of the evidence-history engine."""
