"""Dossier: PySpark-native analytics over documents, parts catalogues, work orders and vehicles."""
