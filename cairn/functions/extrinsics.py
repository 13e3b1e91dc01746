"""Places of sensors on a robot, as 4 x 4 matrices on the driver."""

from __future__ import annotations

import numpy as np

# The mounting that holds where no calibration files are given.
CAMERA_OF_LASER = [[-0.0057, -0.1104, 0.9939, 0.1387], [-1.0000, 0.0003, -0.0057, 0.2613], [0.0006, -0.9938, -0.1107, -0.0840], [0, 0, 0, 1]]
BODY_CAMERA = [[0.0281, -0.0194, 0.9994, 0.1461], [-1.0041, -0.0129, 0.0278, 0.2614], [0.0123, -0.9998, -0.0199, -0.0743], [0, 0, 0, 1]]


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotation closest to a 3 x 3 matrix."""
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v


def body_laser(laser_camera: np.ndarray | None = None, refine: np.ndarray | None = None, body_camera: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(laser in the body's frame, its inverse): body_camera * (laser_camera^-1 * refine)^-1, with body_camera's rotation made exact.

    3 x 4 matrices get a last row. Without all three the default mounting holds.
    """
    given = [laser_camera, refine, body_camera]
    if any(m is None for m in given):
        camera_of_laser, mount = np.array(CAMERA_OF_LASER), np.array(BODY_CAMERA)
    else:
        tlc, tuned, mount = (np.vstack((m, [0, 0, 0, 1])) if np.shape(m) == (3, 4) else np.array(m, float) for m in given)
        camera_of_laser = np.linalg.inv(tlc) @ tuned
    mount = mount.copy()
    mount[:3, :3] = nearest_rotation(mount[:3, :3])
    out = mount @ np.linalg.inv(camera_of_laser)
    return out, np.linalg.inv(out)
