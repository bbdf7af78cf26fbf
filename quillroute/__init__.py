"""quillroute: a PySpark engine for representation-routed retrieval and its evaluation."""
