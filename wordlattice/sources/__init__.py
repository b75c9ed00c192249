"""Text lines and lexicons in, tokens out."""
