"""Column functions and pandas functions over text, tables, boxes and notation."""
