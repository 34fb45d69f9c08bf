"""functions of the evidence-history engine."""
