"""Column functions: text, identifiers, IRIs and Turtle terms. All but NFC are native expressions."""
