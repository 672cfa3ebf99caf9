"""Column functions over text: patterns with one meaning in every engine, and the scalar vocabulary built on them."""
