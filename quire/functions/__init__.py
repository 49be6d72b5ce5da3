from quire.functions.base import register_functions

__all__ = ["register_functions"]
