"""The one error that users see; its text never holds a row's values."""


class CompareError(ValueError):
    """A configuration, input or arithmetic problem that stops a comparison."""
