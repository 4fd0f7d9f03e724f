"""Operations of a training-data pipeline, one module each; see the README's list."""
