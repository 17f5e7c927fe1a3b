"""Bounds that validation and the walkers keep."""

from __future__ import annotations

from dataclasses import dataclass, fields

from framelake.errors import MediaError


@dataclass(frozen=True)
class Limits:
    """The default bounds."""

    max_width: int = 8192
    max_height: int = 8192
    max_channels: int = 32
    max_sample_rate: int = 384_000
    max_tracks: int = 64
    max_allocation: int = 512 << 20
    max_cached_frames: int = 32
    max_decode_samples_per_seek: int = 4096
    max_box_bytes: int = 64 << 20
    max_boxes: int = 100_000
    max_depth: int = 16
    max_samples_per_track: int = 10_000_000
    max_output_samples: int = 1_000_000
    max_encode_batch: int = 64
    max_obus: int = 4096
    max_operating_points: int = 32
    max_tiles: int = 4096

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise MediaError("ResourceLimit", f"{f.name} must let something through")

    @classmethod
    def of(cls, options: dict) -> Limits:
        """Limits from a bag of options, whose numbers may be texts; an unknown name or a value that is no whole number raises."""
        known, found = {f.name for f in fields(cls)}, {}
        for name, value in options.items():
            if name not in known:
                raise MediaError("InvalidInput", f"there is no limit named {name}")
            try:
                found[name] = int(value)
            except (TypeError, ValueError):
                raise MediaError("InvalidInput", f"{name} must be a whole number") from None
            if isinstance(value, float) and value != found[name]:
                raise MediaError("InvalidInput", f"{name} must be a whole number")
        return cls(**found)


DEFAULT = Limits()
