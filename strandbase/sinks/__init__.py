"""Text forms of results: manifest renderings, match tables and line writers."""
