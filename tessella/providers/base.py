"""Model providers: what runs a task over batches, and the registry that finds it."""

from __future__ import annotations

from abc import ABC, abstractmethod


class Provider(ABC):
    """Runs tasks for one provider id. load() is called once a Python worker and runtime key."""

    provider_id: str
    tasks: tuple[str, ...] = ()

    @abstractmethod
    def load(self, task: str, model_id: str, options: dict):
        """An object with run(batch) -> list of results, one for each input, in order."""

    def dimensions(self, model_id: str, options: dict) -> int | None:
        return options.get("dimensions")


_registry: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Adds a provider, or replaces the one of that id."""
    _registry[provider.provider_id] = provider
    return provider


def provider(provider_id: str) -> Provider:
    if provider_id not in _registry:
        raise LookupError(f"no provider {provider_id}")
    return _registry[provider_id]


def registered() -> list[str]:
    return sorted(_registry)
