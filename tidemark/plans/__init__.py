"""From dialect text to a DataFrame: tokens, syntax tree, binding."""
