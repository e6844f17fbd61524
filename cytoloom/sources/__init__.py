"""Sources and sinks: adapters, TSV, manifests, cell stores, a simulator, the bundled example."""
