"""Query plans over the driver tables: stand-in series, registered queries, oracles."""
