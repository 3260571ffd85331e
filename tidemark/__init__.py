"""Audience, traffic and inventory analytics as DataFrame plans."""
