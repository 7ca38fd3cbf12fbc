"""Multi-operator dataflows: audit, extraction, tiling, evaluation and sweeps."""
