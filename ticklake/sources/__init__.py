"""Tables, views, file formats and parsers."""
