class EvidenceError(Exception):
    """Base of the errors that a caller may want to tell apart."""


class InsufficientData(EvidenceError):
    """Nothing was published that could answer."""


class AmbiguousPeriod(EvidenceError):
    """Several periods share the end date that was asked for."""


class ContractViolation(EvidenceError):
    """A source delivered a shape that is not the agreed one."""
