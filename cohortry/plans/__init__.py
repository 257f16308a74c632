from cohortry.plans.segmentation import Segmentation, run

__all__ = ["Segmentation", "run"]
