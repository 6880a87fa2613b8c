"""Physical building blocks: size-checked broadcasts, bounded ordering, checkpoints."""
