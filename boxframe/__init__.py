"""boxframe: documents as tables of positioned text boxes, on Spark."""
