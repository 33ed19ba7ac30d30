"""The root of the engine's errors.

  EngineError
    SelectionError      plans.selection: SyntaxFault, MissingOperand, InvalidPredicate, BindingFault
      CastError         plans.literals: a literal does not fit its column
    AccessDenied        operators.policy: MissingClaim
    CycleError          operators.dag: events that are their own ancestors
    NotFound            sources.collection: no entity has the id
    UnknownCollection   sources.context
    RegistrationError   sources.catalog
"""


class EngineError(Exception):
    """Something asked of the engine cannot be done."""
