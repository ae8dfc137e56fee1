"""DataFrame building blocks, parameterised by column."""
