"""Readers and writers: line records, lists, catalogues, XML and JSON documents, corpora."""
