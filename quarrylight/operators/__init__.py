"""DataFrame operators built from column expressions, joins, windows and MLlib stages."""
