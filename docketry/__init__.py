"""docketry: a PySpark analytics engine for evidence-grade document corpora."""
