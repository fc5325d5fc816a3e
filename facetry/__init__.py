"""facetry: document search and faceted analytics as Spark DataFrame plans."""
