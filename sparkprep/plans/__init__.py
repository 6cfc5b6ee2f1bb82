from .base import FittedStep, load_steps, save_steps

__all__ = ["FittedStep", "load_steps", "save_steps"]
