"""Low-rank completion of large sparse rating matrices on Spark DataFrames."""

from lacuna.plans.estimators import (
    BiScale,
    BiScaleModel,
    CompletionModel,
    SoftImpute,
    SoftImputeALS,
)

__all__ = ["BiScale", "BiScaleModel", "CompletionModel", "SoftImpute", "SoftImputeALS"]
