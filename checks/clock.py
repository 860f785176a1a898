"""A clock for checks of limits: sleeping moves it on."""

from corpuslens.operators.review import Clock


class CountingClock(Clock):
    def __init__(self) -> None:
        self.at = 0.0
        super().__init__(now=lambda: self.at, sleep=self._forward)

    def _forward(self, seconds: float) -> None:
        self.at += seconds
