"""Typed tensor pipelines on Spark."""

from .engine import Pipeline, from_str, load
from .types import arg, audio, composite, image, raw, tensor

__all__ = ["Pipeline", "arg", "audio", "composite", "from_str", "image", "load", "raw", "tensor"]
