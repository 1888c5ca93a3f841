"""The constraint catalogue: rules as data, compiled to DataFrame plans."""
