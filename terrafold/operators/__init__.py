"""DataFrame operators: filters, records, mapping layers, feature collections, spatial joins, topology."""
