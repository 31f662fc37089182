"""Relational and analytic operators over post, thread, label and snapshot tables."""
