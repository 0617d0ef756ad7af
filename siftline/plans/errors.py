"""Errors that callers can tell apart."""


class SearchError(Exception):
    """Base of all errors raised here."""


class InvalidRequest(SearchError):
    pass


class InvalidConfig(SearchError):
    pass


class ParseError(SearchError):
    pass


class FieldNotFound(SearchError):
    def __init__(self, field: str, known: list[str]) -> None:
        super().__init__(f"field {field!r} does not exist or isn't indexed for search; fields: {', '.join(known)}")
        self.field, self.known = field, known


class AllFieldsFiltered(SearchError):
    def __init__(self, wanted: list[str] | None, known: list[str]) -> None:
        super().__init__(f"no searchable field is left of {wanted}; fields: {', '.join(known)}")
