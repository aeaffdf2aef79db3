"""What can be wrong with a tensor, a plan or a notation."""


class TensorError(ValueError):
    """Base of all errors of this package."""


class RankMismatch(TensorError):
    """A tensor has another number of axes than is asked for."""


class ShapeMismatch(TensorError):
    """Two tensors, or a tensor and a target, differ in an axis size."""


class InvalidAxis(TensorError):
    """An axis number is out of range or given twice."""


class StrideLengthMismatch(TensorError):
    """Dims and strides differ in length."""


class OffsetOverflow(TensorError):
    """A strided view reaches outside its buffer."""


class ScalarConversion(TensorError):
    """A value cannot be taken over into the asked type."""


class NonSquare(TensorError):
    """A square matrix is needed."""


class EinsumError(TensorError):
    """Base of errors about contractions."""


class ParseError(EinsumError):
    """The notation cannot be read."""


class DuplicateAxis(EinsumError):
    """A label stands twice where it may stand once."""


class OrphanOutputAxis(EinsumError):
    """An output label has no operand and no size."""


class DimensionMismatch(EinsumError):
    """One label has two sizes."""


class OperandCountMismatch(EinsumError):
    """The notation has another number of operands than were given."""


class TypeMismatch(EinsumError):
    """A real output cannot take a complex result."""


class OutputShapeMismatch(EinsumError):
    """The output to add to has another shape than the result."""
