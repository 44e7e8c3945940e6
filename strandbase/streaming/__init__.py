"""All inputs of this engine are finite tables; there is no streaming operator to offer."""
