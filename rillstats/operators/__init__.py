"""The statistics."""

from .flat import (
    OLS, Count, Covariance, DecayingMean, DecayingRate, DecayingSum, DecayingVariance, FixedPointSum, Lasso, Max, Mean, Min, Moments, Range, Rate, Ridge, Sum, TotalWeights, Variance,
)
from .keyed import BloomFilter, CountMinSketch, DDSketch, HdrHistogram, HyperLogLog, LinearCounting, LinearHistogram, MinHash
from .ordered import CounterRate, EvictingSpaceSaving, EwmaMean, EwmaVariance, FrugalQuantile, ReservoirHistogram, SpaceSaving, TDigest

__all__ = [
    "OLS", "BloomFilter", "Count", "CountMinSketch", "CounterRate", "Covariance", "DDSketch", "DecayingMean", "DecayingRate", "DecayingSum", "DecayingVariance", "EvictingSpaceSaving", "EwmaMean", "EwmaVariance", "FixedPointSum",
    "FrugalQuantile", "HdrHistogram", "HyperLogLog", "Lasso", "LinearCounting", "LinearHistogram", "Max", "Mean", "Min", "MinHash", "Moments", "Range", "Rate", "ReservoirHistogram", "Ridge", "SpaceSaving", "Sum",
    "TDigest", "TotalWeights", "Variance",
]
