"""What can be wrong with a configuration or with two hashes that are compared."""

from __future__ import annotations


class ConfigurationError(ValueError):
    """A hasher or raster operation that can't be built with the given options."""


class InvalidSize(ConfigurationError): ...


class InvalidInterpolation(ConfigurationError): ...


class InvalidKernelSize(ConfigurationError): ...


class InvalidSigma(ConfigurationError): ...


class InvalidBlockSize(ConfigurationError): ...


class InvalidScale(ConfigurationError): ...


class InvalidAlpha(ConfigurationError): ...


class InvalidAngles(ConfigurationError): ...


class InvalidLevel(ConfigurationError): ...


class InvalidGridSize(ConfigurationError): ...


class InvalidCellSize(ConfigurationError): ...


class InvalidBinCount(ConfigurationError): ...


class InvalidRings(ConfigurationError): ...


class InvalidDegree(ConfigurationError): ...


class InvalidFeature(ConfigurationError): ...


class InvalidStorage(ConfigurationError): ...


class InvalidVocabularySize(ConfigurationError): ...


class InvalidMaxKeypoints(ConfigurationError): ...


class InvalidMinHashSize(ConfigurationError): ...


class InvalidSimHashBits(ConfigurationError): ...


class CompareError(ValueError):
    """Two hashes that can't be compared."""


class IncompatibleHash(CompareError): ...


class HashLengthMismatch(CompareError): ...


class NotSameLength(CompareError): ...


class WeightLengthMismatch(CompareError): ...


class OutOfBounds(IndexError):
    """A bit position beyond a hash's bytes."""


class ImageIsNull(ValueError):
    """There is no image to work on."""


#: Messages that Spark expressions raise, by error.
MESSAGES = {
    IncompatibleHash: "incompatible hash types",
    HashLengthMismatch: "hash lengths differ",
    NotSameLength: "hashes are not of the same length",
    WeightLengthMismatch: "the number of weights and of bytes differ",
    OutOfBounds: "bit position out of bounds",
    ImageIsNull: "image is null",
}
