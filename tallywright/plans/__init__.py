"""Complete reports, composed of the operators."""

from tallywright.plans import donors, vacancies

__all__ = ["donors", "vacancies"]
