"""Instruction-corpus and preference-data analytics on Spark."""

from loomframe.translate import History, Lookup, Translator

__version__ = "0.2.0"
__all__ = ["History", "Lookup", "Translator", "__version__"]
