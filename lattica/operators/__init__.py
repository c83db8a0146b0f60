"""Batch operators over entity, relation, triple and conversation tables."""
