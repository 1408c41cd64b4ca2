"""Jobs of several steps: snapshots, evidence packs, evaluation."""
