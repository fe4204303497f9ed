"""arborel: XPath 1.0 to 3.1 queries and XDM operators as Spark plans."""
