"""Relational, graph, clustering and evaluation operators."""
