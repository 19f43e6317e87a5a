"""Rule runs: the append-only store, the registry, evaluation, replay, and what is read back."""
