"""Reading trees, questions, scopes and manifests."""
