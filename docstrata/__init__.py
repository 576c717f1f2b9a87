"""Document-lake analytics on PySpark: validated intake, silver documents, marts, retrieval and streams."""
