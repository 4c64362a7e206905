"""Detectors, in report order. A new one is a class with `name` and `scan`, added to `DETECTORS`."""

from .api import HallucinatedApi
from .instructions import Instructions
from .rework import Rework
from .test_integrity import TestIntegrity

DETECTORS = [Instructions(), TestIntegrity(), Rework(), HallucinatedApi()]
