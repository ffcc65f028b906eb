from balsam.functions.random import uniform

__all__ = ["uniform"]
