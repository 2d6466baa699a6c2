"""Declaration, inspection and rewriting of pipelines."""
