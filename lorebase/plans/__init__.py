"""plans of the evidence-history engine."""
