"""What the driver decides before a scan: patterns, regular expressions, strategy."""
