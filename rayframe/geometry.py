"""Scanner models: parameters, checks, sizing, and what a view and a pixel say about the detector.

A model holds no data. It gives the small table of its views (one row a view, bounded by
the number of views) and, for the projectors, Column expressions over relations that have
the view's columns (p0, p1, p2) and a pixel id `pix` = row * columns + column.
"""
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import functions as F

# Names and defaults of the parameters, and of units of length in millimetres.
DEFAULTS = {
    "delta_det_channel": 1.0, "delta_det_row": 1.0, "det_row_offset": 0.0, "det_channel_offset": 0.0, "alu_unit": None, "alu_value": 1.0,
    "recon_shape": None, "delta_voxel": None, "voxel_row_aspect": 1.0, "voxel_slice_aspect": 1.0,
    "sigma_x": 1.0, "sigma_y": 1.0, "sigma_prox": 1.0, "p": 2.0, "q": 1.2, "T": 1.0, "qggmrf_nbr_wts": (1.0, 1.0, 1.0),
    "auto_regularize_flag": True, "positivity_flag": False, "snr_db": 30.0, "sharpness": 1.0,
    "granularity": (1, 2, 4, 8, 16, 32, 64, 128, 128, 128, 128), "partition_sequence": (2, 4, 6) + (7, 8, 9, 10) * 25,
    "verbose": 1, "max_alpha": 1.5, "use_ror_mask": True,
}
CONE_DEFAULTS = {"recon_slice_offset": 0.0, "axial_pad_fraction": 0.0, "use_curved_detector": False}
UNITS_MM = {"um": 1e-3, "mm": 1.0, "cm": 10.0, "m": 1000.0}
REGULARISATION = ("sigma_y", "sigma_x", "sigma_prox", "p", "q", "T", "qggmrf_nbr_wts", "auto_regularize_flag", "positivity_flag", "snr_db", "sharpness")


def to_alu(value, unit, alu_unit):
    """A length in `unit` as one in `alu_unit`."""
    return value * UNITS_MM[unit] / UNITS_MM[alu_unit]


def support_radius(recon_shape, delta_row, delta_col, use_ror_mask=True):
    """Greatest distance from the axis of what a projector may change: the larger half width, or the half diagonal without the standard mask."""
    rows, cols = 0.5 * recon_shape[0] * delta_row, 0.5 * recon_shape[1] * delta_col
    return max(rows, cols) if use_ror_mask is True else math.hypot(rows, cols)


@dataclass
class Model:
    """A scanner model; `views` is one tuple of view parameters a view."""

    sinogram_shape: tuple
    views: list
    params: dict = field(default_factory=dict)
    kind = None
    view_names = ()
    extra = {}
    damping = None

    def __post_init__(self):
        self.sinogram_shape = tuple(int(n) for n in self.sinogram_shape)
        self.views = [tuple(float(x) for x in (v if isinstance(v, (tuple, list)) else (v,))) for v in self.views]
        given, self.params = self.params, DEFAULTS | self.extra
        unknown = set(given) - set(self.params) - set(self.required())
        if unknown:
            raise NameError(f"unknown parameters {sorted(unknown)}")
        self.params |= given
        if self.params["recon_shape"] is None:
            self.auto_recon_geometry()
            self.params |= {k: v for k, v in given.items() if v is not None}

    # Parameters -----------------------------------------------------------------
    @classmethod
    def required(cls):
        return ()

    def get(self, names):
        """The value of a name, or the list of those of several."""
        if not isinstance(names, str):
            return [self.get(n) for n in names]
        if names == "sinogram_shape":
            return self.sinogram_shape
        if names not in self.params:
            raise NameError(f"{names} is no parameter of {self.kind}")
        return self.params[names]

    def set(self, no_warning=False, **values):
        """Sets parameters. A sigma ends automatic regularisation, sharpness and snr_db start it again; recon_shape and delta_voxel stay as given."""
        for k, v in values.items():
            if k == "sinogram_shape":
                self.sinogram_shape = tuple(v)
                continue
            if k not in self.params and not no_warning:
                raise NameError(f"{k} is no parameter of {self.kind}")
            self.params[k] = v
        if "auto_regularize_flag" not in values:
            if {"sigma_x", "sigma_y", "sigma_prox"} & set(values):
                self.params["auto_regularize_flag"] = False
                if not no_warning:
                    warnings.warn("a sigma was set: automatic regularisation is off")
            elif {"sharpness", "snr_db"} & set(values):
                self.params["auto_regularize_flag"] = True
        return self

    def all_params(self):
        """(required, optional, regularisation) as dicts that `build` takes."""
        required = {"geometry_type": self.kind, "sinogram_shape": self.sinogram_shape, "views": list(self.views)} | {k: self.params[k] for k in self.required()}
        reg = {k: self.params[k] for k in REGULARISATION}
        return required, {k: v for k, v in self.params.items() if k not in reg and k not in required}, reg

    def copy(self, views=None, rows=None, channels=None, **changes):
        """The same model with other views or another detector size; the volume is sized anew where that changes and none is given."""
        v, r, c = self.sinogram_shape
        params = dict(self.params)
        if views is not None or rows is not None or channels is not None:
            params["recon_shape"] = None
        params |= changes
        views = self.views if views is None else list(views)
        keep = {k: params[k] for k in params if k not in ("recon_shape", "delta_voxel", "recon_slice_offset") or params["recon_shape"] is not None}
        return type(self)((len(views), rows or r, channels or c), views, keep)

    def scale_recon_shape(self, row_scale=1.0, col_scale=1.0, slice_scale=1.0):
        """Grows the volume by factors; returns the changes of its three sizes."""
        old = self.params["recon_shape"]
        new = tuple(int(n * s) for n, s in zip(old, (row_scale, col_scale, slice_scale)))
        self.params["recon_shape"] = new
        return tuple(a - b for a, b in zip(new, old))

    # Shapes ---------------------------------------------------------------------
    @property
    def dv(self):
        return self.params["delta_voxel"]

    @property
    def dv_row(self):
        return self.params["voxel_row_aspect"] * self.dv

    @property
    def dv_slice(self):
        return self.params["voxel_slice_aspect"] * self.dv

    def magnification(self):
        return 1.0

    def verify(self):
        """Raises ValueError where the parameters don't fit together."""
        if len(self.views) != self.sinogram_shape[0]:
            raise ValueError(f"{len(self.views)} views are given for {self.sinogram_shape[0]} in the sinogram")
        if any(len(v) != len(self.view_names) for v in self.views):
            raise ValueError(f"each view takes {self.view_names}")
        if self.params["voxel_row_aspect"] <= 0 or self.params["voxel_slice_aspect"] <= 0:
            raise ValueError("voxel aspects must be positive")
        if any(n <= 0 for n in (*self.sinogram_shape, *self.params["recon_shape"])):
            raise ValueError("shapes must be positive")

    def view_table(self, spark):
        """(view, p0, p1, p2): a row a view."""
        rows = [(i, *v, *(0.0,) * (3 - len(v))) for i, v in enumerate(self.views)]
        return spark.createDataFrame(rows, "view int, p0 double, p1 double, p2 double")

    # Expressions ----------------------------------------------------------------
    def _xy(self):
        """x and y of pixel `pix` in the volume."""
        rows, cols, _ = self.params["recon_shape"]
        row, col = F.floor(F.col("pix") / cols), F.col("pix") % cols
        return (col - (cols - 1) / 2) * F.lit(float(self.dv)), (row - (rows - 1) / 2) * F.lit(float(self.dv_row))

    def _turned(self):
        x, y = self._xy()
        c, s = F.cos("p0"), F.sin("p0")
        return c * x - s * y, s * x + c * y

    def _centre(self, u):
        """Channel that u falls on."""
        return (u + F.lit(float(self.params["det_channel_offset"]))) / F.lit(float(self.params["delta_det_channel"])) + (self.sinogram_shape[2] - 1) / 2


class Parallel(Model):
    """One angle a view; slice and detector row are the same axis."""

    kind, view_names = "parallel", ("angle",)

    def auto_recon_geometry(self):
        ddc, ddr = self.get(["delta_det_channel", "delta_det_row"])
        _, rows, channels = self.sinogram_shape
        self.params["delta_voxel"] = ddc
        self.params["recon_shape"] = (math.ceil(channels * ddc / self.dv_row), math.ceil(channels * ddc / self.dv), round(rows * ddr / self.dv))

    def verify(self):
        super().verify()
        if self.params["voxel_slice_aspect"] != 1:
            raise ValueError("a parallel beam has no slice aspect")
        if self.params["recon_shape"][2] != self.sinogram_shape[1]:
            raise ValueError("a parallel beam has as many slices as detector rows")

    def radii(self):
        r = math.ceil(math.ceil(max(self.dv, self.dv_row) / self.params["delta_det_channel"]) / 2)
        return r, r

    def horizontal(self):
        """Columns n_p, width, scale and mag of a (view, pixel)."""
        x, _ = self._turned()
        foot = F.greatest(F.abs(F.cos("p0")) * self.dv, F.abs(F.sin("p0")) * self.dv_row)
        return {"n_p": self._centre(x), "width": foot / F.lit(float(self.params["delta_det_channel"])), "scale": F.lit(float(self.dv * self.dv_row)) / foot, "mag": F.lit(1.0), "depth": F.lit(0.0)}

    def vertical(self):
        return None


class Cone(Model):
    """An angle and a shift along the axis a view; flat or curved detector."""

    kind, view_names, extra = "cone", ("angle", "z_shift"), CONE_DEFAULTS | {"source_detector_dist": None, "source_iso_dist": None}

    # How a cone's update steps are damped slice by slice.
    damping = (0.25, 100.0, 0.7, 0.5)

    def __post_init__(self):
        self.views = [(v, 0.0) if not isinstance(v, (tuple, list)) else tuple(v) for v in self.views]
        super().__post_init__()

    @classmethod
    def required(cls):
        return ("source_detector_dist", "source_iso_dist")

    def magnification(self):
        sdd, sid = self.get(["source_detector_dist", "source_iso_dist"])
        return 1.0 if math.isinf(sdd) else sdd / sid

    def verify(self):
        super().verify()
        if self.params["delta_det_row"] * self.sinogram_shape[1] / 2 + abs(self.params["det_row_offset"]) > self.params["source_detector_dist"]:
            warnings.warn("the cone angle is over 45 degrees: artefacts are likely")

    def auto_recon_geometry(self):
        ddc, ddr, pad = self.get(["delta_det_channel", "delta_det_row", "axial_pad_fraction"])
        _, rows, channels = self.sinogram_shape
        m, sdd = self.magnification(), self.params["source_detector_dist"]
        self.params["delta_voxel"] = ddc / m
        n_rows, n_cols = (round(channels * ddc / d / m) for d in (self.dv_row, self.dv))
        z = [v[1] for v in self.views]
        height = rows * ddr / m
        slices = max(1, math.ceil((height + max(z) - min(z)) / self.dv_slice))
        offset = (min(z) + max(z)) / 2
        # The detector's upper and lower edges, seen at the far side of the support.
        edges = [self.to_uv(e, 0.0)[1] for e in (-0.5, rows - 0.5)]
        far = 1 / m + (0.0 if math.isinf(sdd) else support_radius((n_rows, n_cols), self.dv_row, self.dv, self.params["use_ror_mask"]) / sdd)
        pads = tuple(pad) if isinstance(pad, (tuple, list)) else (pad, pad)
        if len(pads) != 2 or min(pads) < 0:
            raise ValueError("axial_pad_fraction is one number or a (top, bottom) pair, none under 0")
        top, bottom = (math.ceil(f * max(0.0, e * far - height / 2) / self.dv_slice) for f, e in zip(pads, (-min(edges), max(edges))))
        self.params["recon_shape"] = (n_rows, n_cols, slices + top + bottom)
        self.params["recon_slice_offset"] = offset + 0.5 * (bottom - top) * self.dv_slice

    def to_uv(self, m, n):
        """Place (u, v) on the detector of row m and channel n; numbers or Columns."""
        _, rows, channels = self.sinogram_shape
        ddc, ddr, dco, dro = self.get(["delta_det_channel", "delta_det_row", "det_channel_offset", "det_row_offset"])
        return (n - (channels - 1) / 2) * ddc - dco, (m - (rows - 1) / 2) * ddr - dro

    def _extent(self):
        return max(0.5 * self.params["recon_shape"][1] * self.dv, 0.5 * self.params["recon_shape"][0] * self.dv_row)

    def radii(self):
        """(detector rows or channels on each side that a voxel may touch, slices that a detector row may)."""
        sdd, pitch = self.params["source_detector_dist"], min(self.params["delta_det_row"], self.params["delta_det_channel"])
        sid = sdd / self.magnification()
        most, least = (1.0, 1.0) if math.isinf(sdd) else (sdd / (sid - self._extent()), sdd / (sid + self._extent()))
        voxels = (self.dv, self.dv_row, self.dv_slice)
        return math.ceil(math.ceil(max(voxels) * most / pitch) / 2), math.ceil(math.ceil(pitch / (least * min(voxels))) / 2)

    def _mag(self, y):
        sdd = self.params["source_detector_dist"]
        return 1.0 / (F.lit(1.0 / self.magnification()) - (F.lit(0.0) if math.isinf(sdd) else y / F.lit(float(sdd))))

    def horizontal(self):
        x, y = self._turned()
        mag, sdd, ddc = self._mag(y), self.params["source_detector_dist"], self.params["delta_det_channel"]
        if self.params["use_curved_detector"]:
            theta = F.atan2(x, F.lit(float(sdd / self.magnification())) - y)
            u, tilt = theta * sdd, F.lit(1.0)
        else:
            u = mag * x
            theta = F.atan2(u, F.lit(float(sdd)))
            tilt = F.cos(theta)
        foot = F.greatest(F.abs(F.cos(F.col("p0") - theta)) * self.dv, F.abs(F.sin(F.col("p0") - theta)) * self.dv_row)
        return {"n_p": self._centre(u), "width": mag * foot / F.lit(float(ddc)) / tilt, "scale": F.lit(float(self.dv * self.dv_row)) / foot, "mag": mag, "depth": y}

    def _z(self):
        """Height of slice `slice` in a view."""
        return self.dv_slice * (F.col("slice") - (self.params["recon_shape"][2] - 1) / 2) + (F.lit(float(self.params["recon_slice_offset"])) - F.col("p1"))

    def vertical(self):
        """Columns m_p, w_row, factor of a (view, pixel, slice): the row it falls on, its width in rows, and what the tap is multiplied by."""
        v, sdd = F.col("mag") * self._z(), self.params["source_detector_dist"]
        rows, ddr = self.sinogram_shape[1], F.lit(float(self.params["delta_det_row"]))
        m = (v + F.lit(float(self.params["det_row_offset"]))) / ddr + (rows - 1) / 2
        return {"m_p": m, "w_row": F.col("mag") * self.dv_slice / ddr, "factor": 1.0 / F.cos(F.atan2(v, F.lit(float(sdd))))}


class Translation(Cone):
    """A shift in x, y and z a view; the object moves past a fixed cone."""

    kind, view_names, extra = "translation", ("t_x", "t_y", "t_z"), {"source_detector_dist": None, "source_iso_dist": None}

    def __post_init__(self):
        Model.__post_init__(self)

    def magnification(self):
        sdd, sid = self.get(["source_detector_dist", "source_iso_dist"])
        if math.isinf(sdd):
            raise ValueError("without magnification all translated views are alike")
        return sdd / sid

    def verify(self):
        Model.verify(self)

    def auto_recon_geometry(self):
        sdd, sid, ddr, ddc, row, sl = self.get(["source_detector_dist", "source_iso_dist", "delta_det_row", "delta_det_channel", "voxel_row_aspect", "voxel_slice_aspect"])
        shape, self.params["delta_voxel"], self.params["voxel_row_aspect"] = translation_sizing(sdd, sid, ddr, ddc, self.sinogram_shape, self.views, row, sl)
        self.params["recon_shape"] = shape

    def radii(self):
        sdd, sid = self.get(["source_detector_dist", "source_iso_dist"])
        near = sid - 0.5 * self.params["recon_shape"][0] * self.dv_row - max(v[1] for v in self.views)
        if near <= 0:
            raise ValueError("the volume reaches into the source")
        r = math.ceil(math.ceil(max(self.dv, self.dv_slice) * sdd / near / min(self.params["delta_det_row"], self.params["delta_det_channel"])) / 2)
        if r > 4:
            warnings.warn("a voxel may fall on a hundred detector cells: use smaller voxels")
        return r, r

    def horizontal(self):
        x, y = self._xy()
        x, y = x - F.col("p0"), y - F.col("p1")
        mag, ddc = self._mag(y), F.lit(float(self.params["delta_det_channel"]))
        u = mag * x
        return {"n_p": self._centre(u), "width": mag * self.dv / ddc, "scale": F.lit(float(self.dv_row)) / F.cos(F.atan2(u, F.lit(float(self.params["source_detector_dist"])))), "mag": mag, "depth": y}

    def _z(self):
        return self.dv_slice * (F.col("slice") - (self.params["recon_shape"][2] - 1) / 2) - F.col("p2")


class MultiAxis(Model):
    """An azimuth and an elevation a view, parallel rays."""

    kind, view_names, extra = "multiaxis_parallel", ("azimuth", "elevation"), {"recon_slice_offset": 0.0}

    def auto_recon_geometry(self):
        ddc, ddr = self.get(["delta_det_channel", "delta_det_row"])
        _, rows, channels = self.sinogram_shape
        flat = max(0.1, min(abs(math.cos(v[1])) for v in self.views))
        self.params["delta_voxel"] = ddc
        self.params["recon_shape"] = (math.floor(channels * ddc / self.dv_row), math.floor(channels * ddc / self.dv), math.floor(2 * (rows * ddr / 2 / flat) / self.dv_slice))

    def radii(self):
        across = max(self.dv, self.dv_row)
        u = math.ceil(math.ceil(across / self.params["delta_det_channel"]) / 2)
        z, xy = (max(abs(f(v[1])) for v in self.views) for f in (math.cos, math.sin))
        v = math.ceil(math.ceil(max(z * self.dv_slice, xy * across) / self.params["delta_det_row"]) / 2)
        return max(u, v), max(u, v)

    def horizontal(self):
        x, y = self._turned()
        foot = F.greatest(F.abs(F.cos("p0")) * self.dv, F.abs(F.sin("p0")) * self.dv_row)
        return {"n_p": self._centre(x), "width": foot / F.lit(float(self.params["delta_det_channel"])), "scale": F.lit(float(self.dv * self.dv_row)) / foot, "mag": F.lit(1.0), "depth": y}

    def vertical(self):
        c, s, ddr = F.cos("p1"), F.sin("p1"), F.lit(float(self.params["delta_det_row"]))
        z = self.dv_slice * (F.col("slice") - (self.params["recon_shape"][2] - 1) / 2) + F.lit(float(self.params["recon_slice_offset"]))
        m = (z * c + F.col("depth") * s + F.lit(float(self.params["det_row_offset"]))) / ddr + (self.sinogram_shape[1] - 1) / 2
        width = F.greatest(F.abs(c) * self.dv_slice, F.abs(s) * F.abs(F.sin("p0")) * self.dv, F.abs(s) * F.abs(F.cos("p0")) * self.dv_row) / ddr
        return {"m_p": m, "w_row": width, "factor": F.lit(float(self.dv_slice)) / ddr / width}


class Image(Model):
    """No scanner: the sinogram is the volume itself (rows, columns, slices), for denoising."""

    kind, view_names = "denoiser", ()

    def __post_init__(self):
        shape = self.sinogram_shape
        self.views = [()] * shape[0]
        super().__post_init__()

    def auto_recon_geometry(self):
        self.params["recon_shape"], self.params["delta_voxel"] = self.sinogram_shape, 1.0


KINDS = {c.kind: c for c in (Parallel, Cone, Translation, MultiAxis)}


def make(kind, sinogram_shape, angles=None, source_detector_dist=None, source_iso_dist=None, z_shifts=None, translations=None, **params):
    """A model by the name of its geometry."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {sorted(KINDS)}")
    distances = {"source_detector_dist": source_detector_dist, "source_iso_dist": source_iso_dist}
    if kind == "cone":
        return Cone(sinogram_shape, list(zip(angles, z_shifts or [0.0] * len(angles))), params | distances)
    if kind == "translation":
        return Translation(sinogram_shape, translations, params | distances)
    return KINDS[kind](sinogram_shape, angles, params)


def build(required, optional=None, regularisation=None):
    """A model from the dicts of all_params; a given recon_shape stays."""
    r = dict(required)
    kind, shape, views = r.pop("geometry_type"), r.pop("sinogram_shape"), r.pop("views")
    return KINDS[kind](shape, views, r | dict(optional or {}) | dict(regularisation or {}))


def detector_crop(required, optional, top, bottom, left, right):
    """(required, optional) after rows and channels were cut off: a smaller shape and moved offsets."""
    views, rows, channels = required["sinogram_shape"]
    if min(top, bottom, left, right) < 0 or top + bottom >= rows or left + right >= channels:
        raise ValueError("the cut leaves no detector")
    required = required | {"sinogram_shape": (views, rows - top - bottom, channels - left - right)}
    moves = {"det_row_offset": (bottom - top) / 2 * optional.get("delta_det_row", 1.0), "det_channel_offset": (right - left) / 2 * optional.get("delta_det_channel", 1.0)}
    return required, optional | {k: optional[k] + v for k, v in moves.items() if k in optional}


def config_crop(rows, channels, row_offset, channel_offset, delta_row, delta_channel, *, top=0, bottom=0, sides=0):
    """(rows, channels, row offset, channel offset) after a cut."""
    r, o = detector_crop({"sinogram_shape": (0, rows, channels)}, {"det_row_offset": row_offset, "det_channel_offset": channel_offset, "delta_det_row": delta_row, "delta_det_channel": delta_channel}, top, bottom, sides, sides)
    return (*r["sinogram_shape"][1:], o["det_row_offset"], o["det_channel_offset"])


def translation_grid(spark, nx, nz, dx, dz):
    """(view, t_x, t_y, t_z): an x-z grid of shifts about 0, x running fastest."""
    i = F.col("id")
    x, z = i % nx, F.floor(i / nx)
    return spark.range(nx * nz).select(i.cast("int").alias("view"), ((x - (nx - 1) / 2) * float(dx)).alias("t_x"), F.lit(0.0).alias("t_y"), ((z - (nz - 1) / 2) * float(dz)).alias("t_z"))


def translation_vectors(nx, nz, dx, dz):
    """The same grid as a list, as a Translation model takes it."""
    return [((x - (nx - 1) / 2) * dx, 0.0, (z - (nz - 1) / 2) * dz) for z in range(nz) for x in range(nx)]


def translation_sizing(sdd, sid, delta_row, delta_channel, sinogram_shape, vectors, row_aspect=1.0, slice_aspect=1.0):
    """(volume shape, voxel width, row aspect) for a translation scan.

    Voxels are as wide as a detector cell at the axis and as deep as views can tell apart;
    rows are so many that voxels and measurements balance, short of the source.
    """
    n_views, n_rows, n_channels = sinogram_shape
    at_axis = (delta_row * sid / sdd, delta_channel * sid / sdd)
    slopes = (delta_channel * n_channels / 4 / sdd, delta_row * n_rows / 4 / sdd)
    width = max(at_axis)
    depth = max(max(4 * a / s for a, s in zip(at_axis, slopes)), width)
    if row_aspect == 1.0:
        row_aspect = depth / width
    else:
        depth = row_aspect * width
    reach = [max(v[i] for v in vectors) - min(v[i] for v in vectors) for i in range(3)]
    cols, slices = math.ceil(reach[0] / width), math.ceil(reach[2] / (slice_aspect * width))
    per_view = (cols + n_rows) * (slices + n_channels) / n_views
    rows = min(2 * math.ceil(n_channels * n_rows / per_view), math.floor((sid - reach[1]) / depth))
    return (int(rows), int(cols), int(slices)), float(width), float(row_aspect)


def helical_slices(model, pitch):
    """(first, past the last) slice seen for at least half a turn of a helical scan."""
    shifts, n = [v[1] for v in model.views], model.params["recon_shape"][2]
    trim = 0.5 * model.sinogram_shape[1] * model.params["delta_det_row"] / model.magnification() * max(pitch - 1.0, 0.0)
    z = [model.dv_slice * (k - (n - 1) / 2) + model.params["recon_slice_offset"] for k in range(n)]
    seen = [k for k in range(n) if min(shifts) + trim <= z[k] <= max(shifts) - trim]
    if not seen:
        raise ValueError("no slice is seen for half a turn")
    return seen[0], seen[-1] + 1
