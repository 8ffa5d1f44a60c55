from cohortry.functions import scalar

__all__ = ["scalar"]
