"""Independent DuckDB SQL oracles for the registered queries."""
