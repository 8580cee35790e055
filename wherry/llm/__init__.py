"""Training-data operators: ten independent corpus operators over documents and pages."""
