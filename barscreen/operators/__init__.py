"""Relational and recursive operators on bars, actions and signals."""
