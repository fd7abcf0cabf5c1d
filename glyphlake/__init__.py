"""Page-image, glyph and text-layout operators as Spark DataFrame plans."""
